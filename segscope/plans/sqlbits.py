"""SQL text helpers for the DuckDB oracle strings (the same rounding rules as
``segscope.functions.columns``)."""


def R(expr: str, d: int = 2) -> str:
    """Round half away from zero through a DECIMAL cast, as double."""
    return f"CAST(ROUND(CAST(CAST({expr} AS DOUBLE) AS DECIMAL(38,{d + 6})), {d}) AS DOUBLE)"


def PCT(a: str, b: str, d: int | None = 2) -> str:
    v = f"CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100"
    inner = R(v, d) if d is not None else v
    return f"(CASE WHEN CAST({b} AS DOUBLE) <> 0 THEN {inner} END)"


def MONEY(x: str) -> str:
    """Numeric column -> DECIMAL(18,2) the way ``indicators.money`` does it."""
    return f"CAST(ROUND(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,10)), 2) AS DECIMAL(18,2))"


def EXACT(x: str) -> str:
    return f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,10))"
