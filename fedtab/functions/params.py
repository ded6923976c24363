"""Column expressions on parameter names (#8-#11).

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference's naming conventions.
HEAD_KEYWORDS = ("score", "classifier", "classification_head")
LORA_MARK = "lora_"
LORA_A = "lora_A"
LORA_B = "lora_B"
FACTOR_SUFFIX_PATTERN = r"lora_[AB]\.default\.weight$"
HALF_DTYPES = ("float16", "bfloat16")
METHODS = ("standard_lora", "ffa_lora", "rolora")
MB = 1024 * 1024


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_head(param: str | Column) -> Column:
    """Head = name holds a head keyword and no ``lora_`` mark."""
    p = _c(param)
    has_kw = None
    for kw in HEAD_KEYWORDS:
        cond = p.contains(kw)
        has_kw = cond if has_kw is None else (has_kw | cond)
    return has_kw & ~p.contains(LORA_MARK)


def component(param: str | Column) -> Column:
    """#8: 'lora_A' / 'lora_B' / 'head' / 'other'; A is tested before B before head."""
    p = _c(param)
    return (F.when(p.contains(LORA_A), F.lit("lora_A"))
            .when(p.contains(LORA_B), F.lit("lora_B"))
            .when(is_head(p), F.lit("head"))
            .otherwise(F.lit("other")))


def transmits(param: str | Column, method: str | Column, round_: str | Column) -> Column:
    """#9: is the parameter trained and sent by ``method`` in ``round``?

    standard: A, B and head; ffa: B and head; rolora: B and head on odd rounds,
    A and head on even rounds. Other parameters are never sent.
    """
    p, m, r = _c(param), _c(method), _c(round_)
    odd = (r % 2) != 0
    lora = (F.when(m == "standard_lora", F.lit(True))
            .when(m == "ffa_lora", p.contains(LORA_B))
            .when(m == "rolora", F.when(odd, p.contains(LORA_B)).otherwise(p.contains(LORA_A)))
            .otherwise(F.lit(False)))
    return is_head(p) | (p.contains(LORA_MARK) & lora)


def layer_key(param: str | Column) -> Column:
    """#10: strip the factor suffix so the A and B of one layer share a key."""
    return F.regexp_replace(_c(param), FACTOR_SUFFIX_PATTERN, "")


def element_width(dtype: str | Column) -> Column:
    """Bytes per value: 2 for half types, 4 for everything else (also 8-byte types)."""
    return F.when(_c(dtype).isin(*HALF_DTYPES), F.lit(2)).otherwise(F.lit(4))


def element_bytes(dtype: str | Column, n_rows: str | Column, n_cols: str | Column) -> Column:
    """#11: bytes of one parameter tensor."""
    return (element_width(dtype) * _c(n_rows).cast("long") * _c(n_cols).cast("long")).cast("long")
