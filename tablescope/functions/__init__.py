from tablescope.functions.exprs import (
    age_days,
    money,
    numeric_columns,
    ratio,
    round_half_up,
    type_name,
)

__all__ = ["age_days", "money", "numeric_columns", "ratio", "round_half_up", "type_name"]
