"""Predicates on features, their catalogue, and strategies as conjunctions that compile to one column expression."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bars import h1_of
from ..plans.storage import written
from . import features as ft

#: The exit grid, the most predicates of a strategy, and the catalogue's thresholds by family.
STOPS, TARGETS, HOLDS, MOST = (1.0, 1.5, 2.0, 3.0), (1.0, 1.5, 2.0, 3.0, 4.0), (12, 24, 48, 96), 4
BOTH = (">", "<")
FAMILIES = (
    ([f"trend_close_ema_{n}" for n in ft.EMA], BOTH, (0.0,)),
    ([f"trend_ema_slope_{n}_{k}" for n in ft.EMA for k in ft.SLOPE], BOTH, (0.0,)),
    ([f"trend_ema_pair_{a}_{b}" for a in ft.EMA for b in ft.EMA if a < b], BOTH, (0.0,)),
    ([f"trend_breakout_high_{n}" for n in ft.BREAKOUT], (">",), (0.0,)),
    ([f"trend_breakout_low_{n}" for n in ft.BREAKOUT], ("<",), (0.0,)),
    ([f"momentum_roc_atr_{n}" for n in ft.ROC], BOTH, (-1.0, 0.0, 1.0)),
    ([f"momentum_rsi_{ft.RSI_N}"], BOTH, (30.0, 40.0, 50.0, 60.0, 70.0)),
    ([f"momentum_willr_{n}" for n in ft.WILLR], BOTH, (-80.0, -50.0, -20.0)),
    ([f"volatility_atr_regime_{n}_{ft.REGIME_N}" for n in ft.ATR_REGIME], BOTH, (0.0,)),
    ([f"volatility_bb_upper_{n}" for n in ft.BANDS], (">",), (0.0,)),
    ([f"volatility_bb_lower_{n}" for n in ft.BANDS], ("<",), (0.0,)),
    ([f"volatility_bb_middle_{n}" for n in ft.BANDS], BOTH, (0.0,)),
    ([f"volatility_compression_{n}" for n in ft.BANDS], ("==",), (-1.0, 1.0)),
    ([f"structure_last_{d}" for d in ft.DEPTHS], ("==",), (1.0, 2.0, 3.0, 4.0)),
    ([f"structure_break_high_{d}" for d in ft.DEPTHS], (">",), (0.0,)),
    ([f"structure_break_low_{d}" for d in ft.DEPTHS], ("<",), (0.0,)),
    ([f"structure_fractal_{s}_{d}" for s in ("high", "low") for d in ft.DEPTHS], ("==",), (1.0,)),
)
FLIP = {">": "<", "<": ">", "==": "=="}


@dataclass(frozen=True, order=True)
class Predicate:
    feature: str
    op: str
    value: float

    def oriented(self) -> Predicate:
        """A pair of means is named fast before slow; the other order means the opposite."""
        head, *rest = self.feature.rsplit("_", 2)
        if head == "trend_ema_pair" and int(rest[0]) > int(rest[1]):
            return Predicate(f"{head}_{rest[1]}_{rest[0]}", FLIP[self.op], 0.0 - self.value)
        return self

    def column(self):
        """Its truth; a missing feature is false."""
        c, v = F.col(self.feature), F.lit(float(self.value))
        return F.coalesce({">": c > v, "<": c < v, "==": c == v}[self.op], F.lit(False))


def catalogue() -> list[Predicate]:
    return sorted(Predicate(f, op, v) for fs, ops, vs in FAMILIES for f in fs for op in ops for v in vs)


@dataclass(frozen=True)
class Strategy:
    """A conjunction of predicates with its exits; equal strategies have equal hashes whatever their spelling."""

    symbol: str
    direction: int
    predicates: tuple[Predicate, ...]
    stop: float
    target: float
    hold: int

    def __post_init__(self):
        ps = tuple(sorted({p.oriented() for p in self.predicates}))
        if self.direction not in (1, -1) or not 1 <= len(ps) <= MOST or self.stop <= 0 or self.target <= 0 or self.hold < 1:
            raise ValueError("not a strategy")
        object.__setattr__(self, "predicates", ps)

    def to_json(self) -> str:
        body = {"symbol": self.symbol, "direction": self.direction, "predicates": [[p.feature, p.op, float(p.value)] for p in self.predicates], "stop": float(self.stop), "target": float(self.target), "hold": int(self.hold)}
        return json.dumps(body, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Strategy:
        d = json.loads(text)
        return Strategy(d["symbol"], d["direction"], tuple(Predicate(*p) for p in d["predicates"]), d["stop"], d["target"], d["hold"])

    def hash(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def signal(self):
        return reduce(lambda a, b: a & b, (p.column() for p in self.predicates))


def signal_bitmaps(table: DataFrame, predicates: list[Predicate]) -> DataFrame:
    """symbol, predicate, bucket, bits: a bitmap per 32,768 bars, built map-side and united by one shuffle."""
    flags = F.array(*[F.when(p.column(), F.lit(i)) for i, p in enumerate(predicates)])
    rows = table.select("symbol", "bar_idx", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("predicate"))
    rows = rows.select("symbol", "predicate", F.bitmap_bucket_number("bar_idx").alias("bucket"), F.bitmap_bit_position("bar_idx").alias("bit"))
    return rows.groupBy("symbol", "predicate", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def predicate_counts(spark, sf_dir: str) -> DataFrame:
    """How often each predicate of the catalogue holds, per symbol, by bitmaps of the written features; 0 where it never
    does. In one aggregate, 170 sums over 77 windows would be too much for generated code."""
    d, ps = written(ft.feature_table(written(h1_of(spark, sf_dir)))), catalogue()
    names = F.array(*[F.struct(F.lit(f"p{i}").alias("name"), F.lit(i).alias("predicate")) for i in range(len(ps))])
    counts = signal_bitmaps(d, ps).groupBy("symbol", "predicate").agg(F.sum(F.bitmap_count("bits")).cast("long").alias("n"))
    every = d.select("symbol").distinct().select("symbol", F.inline(names))
    return every.join(counts, ["symbol", "predicate"], "left").select("symbol", F.col("name").alias("predicate"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def predicate_bit_counts(spark, sf_dir: str) -> DataFrame:
    """The same for the window features, by bitmaps."""
    d = ft.with_atr(h1_of(spark, sf_dir))
    d = d.withColumns(ft.window_features(d))
    ps = [p for p in catalogue() if p.feature in d.columns]
    names = F.array(*[F.lit(f"{p.feature} {p.op} {p.value:g}") for p in ps])
    bits = signal_bitmaps(d, ps).withColumn("n", F.bitmap_count("bits"))
    return bits.groupBy("symbol", names[F.col("predicate")].alias("predicate")).agg(F.sum("n").cast("long").alias("n"))


QUERIES = {"predicate_bit_counts": predicate_bit_counts, "predicate_counts": predicate_counts}


def _bits_sql() -> str:
    inner = ft.ORACLE["features_windows"]
    have = [*ft.window_features_names()]
    ps = [p for p in catalogue() if p.feature in have]
    rows = " UNION ALL ".join(f"SELECT symbol, '{p.feature} {p.op} {p.value:g}' AS predicate, count(*) AS n FROM f WHERE {p.feature} {'=' if p.op == '==' else p.op} {p.value} GROUP BY symbol" for p in ps)
    return f"WITH f AS ({inner}) {rows}"


ORACLE = {"predicate_bit_counts": _bits_sql()}


def _counts_sql() -> str:
    ps = catalogue()
    terms = ", ".join(f"count(*) FILTER (WHERE {p.feature} {'=' if p.op == '==' else p.op} {p.value}) AS p{i}" for i, p in enumerate(ps))
    f = f"w AS ({ft.ORACLE['features_windows']}), s AS ({ft.ORACLE['features_structure']}), r AS ({ft.ORACLE['features_recurrent']})"
    return f"WITH {f}, g AS (SELECT symbol, {terms} FROM w JOIN s USING (symbol, bar_idx) JOIN r USING (symbol, bar_idx) GROUP BY symbol) UNPIVOT g ON COLUMNS(* EXCLUDE symbol) INTO NAME predicate VALUE n"


ORACLE["predicate_counts"] = _counts_sql()
