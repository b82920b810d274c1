"""Table contracts: columns, types and row rules, checked in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ivlattice.functions.numeric import finite


class ContractError(ValueError):
    """A table broke its contract; the message names the columns or rules."""


@dataclass(frozen=True)
class Contract:
    """Columns with types, which of them may be null, and rules that must not be false.

    ``strict`` contracts refuse unknown columns. Values are cast to the declared
    type; a value that does not fit counts as a breach of its column.
    """

    name: str
    columns: str
    nullable: frozenset[str] = frozenset()
    rules: dict[str, str] = field(default_factory=dict)
    finite: frozenset[str] = frozenset()
    strict: bool = True

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(self.columns)

    def shaped(self, df: DataFrame) -> DataFrame:
        """Declared columns in order, cast; raises for missing or unknown ones (no job)."""
        want = [f.name for f in self.schema]
        missing = [c for c in want if c not in df.columns]
        extra = [c for c in df.columns if c not in want] if self.strict else []
        if missing or extra:
            raise ContractError(f"{self.name}: missing {missing}, unknown {extra}")
        rest = [] if self.strict else [df[f"`{c}`"] for c in df.columns if c not in want]
        return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in self.schema], *rest)

    def checks(self) -> dict[str, Column]:
        out = {f"{f.name} is null": F.col(f.name).isNull() for f in self.schema if f.name not in self.nullable}
        out |= {f"{c} is not finite": F.col(c).isNotNull() & ~finite(c) for c in sorted(self.finite)}
        return out | {rule: ~F.coalesce(F.expr(sql), F.lit(True)) for rule, sql in self.rules.items()}

    def breaches(self, df: DataFrame) -> dict[str, int]:
        """Number of rows that break each rule, those with none left out."""
        checks = self.checks()
        row = self.shaped(df).agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())]).first()
        return {name: row[f"c{i}"] for i, name in enumerate(checks) if row[f"c{i}"]}

    def breach_counts(self, df: DataFrame) -> DataFrame:
        """rule, n: as ``breaches``, for a check that is itself a table. A loose contract's rules may use other columns of ``df``."""
        checks = self.checks()
        one = self.shaped(df).agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
        pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("n")) for i, name in enumerate(checks)])
        return one.select(F.inline(pairs)).filter("n > 0")

    def validate(self, df: DataFrame) -> DataFrame:
        broken = self.breaches(df)
        if broken:
            raise ContractError(f"{self.name}: {broken}")
        return self.shaped(df)

    def observed(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        """The shaped table with its breaches counted by whatever job writes it."""
        seen = Observation(self.name)
        return self.shaped(df).observe(seen, *[F.count_if(c).alias(n) for n, c in self.checks().items()]), seen


TRADES_OPTIONS = Contract(
    "trades_options",
    "ts timestamp, instrument string, expiry timestamp, strike double, cp string, price_btc double, iv double, amount double, index_price double, trade_id string, block_flag boolean, source string",
    frozenset({"expiry", "strike", "cp", "price_btc", "iv", "amount", "index_price"}),
)
TRADES_FUTURES = Contract(
    "trades_futures", "ts timestamp, instrument string, price double, amount double, index_price double, trade_id string, block_flag boolean, source string", frozenset({"price", "amount", "index_price"})
)
OHLC = Contract("ohlc", "ts timestamp, instrument string, open double, high double, low double, close double, volume double", frozenset({"open", "high", "low", "close", "volume"}))
DVOL = Contract("dvol", "ts timestamp, currency string, open double, high double, low double, close double", frozenset({"open", "high", "low", "close"}))
FUNDING = Contract("funding", "ts timestamp, instrument string, interest_1h double, interest_8h double, index_price double", frozenset({"interest_1h", "interest_8h", "index_price"}))
DELIVERY_PRICES = Contract("delivery_prices", "date string, index string, delivery_price double", frozenset({"delivery_price"}))
INSTRUMENTS = Contract("instruments", "instrument string, kind string, expiry timestamp, strike double, cp string, creation_ts timestamp", frozenset({"expiry", "strike", "cp", "creation_ts"}))
QUOTE_CHAIN = Contract(
    "quote_chain", "symbol string, timestamp long, type string, strike_price double, expiration long, mark_iv double, underlying_price double", frozenset({"mark_iv", "underlying_price"}), strict=False
)
QUOTES_NORM = Contract(
    "quotes_norm",
    "snap_date date, currency string, expiry timestamp, tau double, strike double, cp string, forward double, k double, iv_obs double, iv_source string, usd_premium double, size double, staleness_s double, quality_flags long, fwd_method string",
    rules={
        "tau > 0": "tau > 0",
        "strike > 0": "strike > 0",
        "forward > 0": "forward > 0",
        "cp": "cp IN ('C', 'P')",
        "iv band": "iv_obs BETWEEN 0.01 AND 5",
        "iv source": "iv_source IN ('trade', 'mark', 'mid')",
        "premium": "usd_premium >= 0",
        "size": "size >= 0",
        "staleness": "staleness_s >= 0",
        "flags": "quality_flags >= 0",
        "method": "fwd_method IN ('pcp', 'future', 'index_carry')",
    },
    finite=frozenset({"k"}),
)
SPLIT_MANIFEST = Contract("split_manifest", "fold_id long, day date, split string, tune_hyperparameters boolean", rules={"fold": "fold_id >= 0", "split": "split IN ('train', 'validation', 'test')"})
