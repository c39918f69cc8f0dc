from shelfprice.functions.calendar import holiday_flag, month_name, seasonal_factor, weekend_flag
from shelfprice.functions.numeric import cents, clamp, from_cents, round_to, safe_ratio, to_cents
from shelfprice.functions.parsing import parse_date, parse_number

__all__ = [
    "cents", "clamp", "from_cents", "holiday_flag", "month_name", "parse_date", "parse_number",
    "round_to", "safe_ratio", "seasonal_factor", "to_cents", "weekend_flag",
]
