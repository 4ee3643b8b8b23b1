"""The per-source panel (``ft_{kind}_{source}`` columns on a dense calendar).

The columns come from the data: of each kind the ``top`` sources with the most days, or all of them.  Internally long: each kind contributes
(symbol, date, source, avg_sentiment); ONE aggregate gathers a symbol-day's cells of all kinds in a map, which is joined once to the spine and spread
to columns.  The spine spans all kinds' symbols and the global day range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggs import top_sources
from ..operators.panel import bounded_broadcast, union_files, union_symbols
from ..session import cut_lineage

MAX_SOURCES = 10_000  # columns of one kind at most; a table has no more


def discover_sources(daily: DataFrame, source: str, day: str, top: int | None) -> list[str]:
    """Names of the ``top`` sources by distinct days (all, if none), in that order, ties by name; null is no source."""
    rows = top_sources(daily.where(F.col(source).isNotNull()), source, day, top or MAX_SOURCES + 1).select(source).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; give a number to keep")
    return [r[0] for r in rows]


def build_source_panel(kinds: dict[str, tuple[DataFrame, str]], top: dict[str, int] | None = None, prices: DataFrame | None = None,
                       index: DataFrame | None = None, day: str = "date") -> DataFrame:
    """``kinds`` maps a kind to its daily frame (symbol, day, source, avg_sentiment) and the name of its source column; ``top`` bounds a
    kind's sources.  Of repeated cells the greatest value counts; symbol-days without a cell are null."""
    # the per-kind daily frames (symbol x day x source: small, already aggregated) feed the sources, the spine, the range and the cells
    kinds = {k: (cut_lineage(f), src) for k, (f, src) in kinds.items()}
    frames = [f.select("symbol", F.col(day).alias("dt")) for f, _ in kinds.values()]
    syms, rng = union_symbols(frames)
    b = rng.select(F.struct("lo", "hi")).scalar()
    lo, hi = b.getField("lo"), b.getField("hi")
    out = syms.select("symbol", F.explode(F.sequence(lo, hi)).alias("dt"))
    names, cells = [], []
    for kind, (f, src) in kinds.items():
        sources = discover_sources(f, src, day, (top or {}).get(kind))
        names += [f"ft_{kind}_{s}" for s in sources]
        wanted = f.sparkSession.createDataFrame([(s,) for s in sources], f"{src} {f.schema[src].dataType.simpleString()}")
        kept = f.join(bounded_broadcast(wanted, known_bound=len(sources)), src, "left_semi")
        cells.append(kept.select("symbol", F.col(day).alias("dt"), F.concat(F.lit(f"ft_{kind}_"), F.col(src).cast("string")).alias("c"), F.col("avg_sentiment").cast("double").alias("v")))
    one = union_files(cells).where("v is not null").groupBy("symbol", "dt", "c").agg(F.max("v").alias("v"))
    wide = one.groupBy("symbol", "dt").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("__cells"))
    out = out.join(wide, ["symbol", "dt"], "left").select("symbol", "dt", *[F.element_at("__cells", F.lit(n)).alias(n) for n in names])
    if prices is not None:
        out = out.join(prices.select("symbol", "dt", "open", "close", "high", "low"), ["symbol", "dt"], "left")
    if index is not None:
        out = out.join(bounded_broadcast(index.select("dt", "sp500_open", "sp500_close")), ["dt"], "left")
    return out


def stacked(panel: DataFrame, keys: tuple[str, ...] = ("symbol", "dt")) -> DataFrame:
    """The panel in long form: (keys, column, value) of every cell that is not null."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in panel.columns if c not in keys])
    return panel.select(*keys, F.explode(F.filter(cells, lambda x: x["value"].isNotNull())).alias("x")).select(*keys, "x.column", "x.value")
