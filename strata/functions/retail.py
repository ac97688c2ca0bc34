"""Row-level retail rules. Every limit is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from strata.functions.bands import at_least, exact, first_label, up_to
from strata.functions.exprs import col, iso_weekday, whole

# Default limits and labels of the retail classes.
DELIVERY_STEPS = ((3, "Fast"), (7, "Standard"))
DELIVERY_SLOW = "Slow"
NOT_SHIPPED = "Not Shipped"
ORDER_SIZE_STEPS = ((1000, "Large"), (500, "Medium"), (100, "Small"))
ORDER_SIZE_REST = "Micro"
MARGIN_STEPS = ((0.3, "High Margin"), (0.1, "Medium Margin"), (0, "Low Margin"))
MARGIN_REST = "Loss"
VOLUME_STEPS = ((100, "High Volume"), (50, "Medium Volume"))
VOLUME_REST = "Low Volume"
ABC_SHARES = ((0.8, "A"), (0.95, "B"))
ABC_REST = "C"
CUSTOMER_TIERS = ("VIP", "Frequent", "High Value", "Regular")
CUSTOMER_SEGMENTS = ("VIP", "Frequent", "Regular")
PRODUCT_TIERS = ("Star", "High Performer", "Popular", "High Margin", "Standard")


def net_sales(sales="sales", discount="discount") -> Column:
    """Sales less the discount amount."""
    return col(sales) - col(discount)


def margin_ratio(profit="profit", sales="sales") -> Column:
    """Profit per unit of sales; 0 where nothing was sold."""
    share = F.try_divide(col(profit).cast("double"), col(sales).cast("double"))
    return F.when(col(sales) > 0, share).otherwise(F.lit(0.0))


def margin_pct(profit="profit", sales="sales") -> Column:
    return margin_ratio(profit, sales) * 100


def shipped(order_date="order_date", ship_date="ship_date") -> Column:
    """True for a line with a plausible ship date (none before its order date)."""
    return F.coalesce(col(ship_date) >= col(order_date), F.lit(False))


def delivery_days(order_date="order_date", ship_date="ship_date") -> Column:
    return F.when(shipped(order_date, ship_date), F.date_diff(col(ship_date), col(order_date)))


def delivery_status(days: Column | str = "delivery_days", steps=DELIVERY_STEPS) -> Column:
    return F.when(col(days).isNull(), NOT_SHIPPED).otherwise(up_to(days, steps, DELIVERY_SLOW))


def date_parts(c="order_date", prefix="order_", day=False) -> dict[str, Column]:
    parts = {
        "year": F.year(c),
        "month": F.month(c),
        "quarter": F.quarter(c),
        "day_of_week": iso_weekday(c),
    }
    if day:
        parts["day"] = F.dayofmonth(c)
    return {prefix + name: whole(part) for name, part in parts.items()}


def order_size(amount="net_sales", steps=ORDER_SIZE_STEPS) -> Column:
    return at_least(amount, steps, ORDER_SIZE_REST)


def profitability(profit="profit", sales="sales", steps=MARGIN_STEPS) -> Column:
    """Margin class, tested on exact products so no limit is missed by rounding."""
    p, s = col(profit), col(sales)
    rules = [(F.when(s > 0, p >= s * exact(limit)).otherwise(exact(limit) <= 0), label) for limit, label in steps]
    return first_label(rules, MARGIN_REST)


def priority(category: Column | str, high: Sequence[str], labels=("High", "Low")) -> Column:
    return F.when(col(category).isin(list(high)), labels[0]).otherwise(labels[1])


def years_between(as_of: Column, since: Column | str) -> Column:
    """Completed years."""
    return whole(F.floor(F.months_between(as_of, col(since)) / 12))


def gross_margin(revenue, cost) -> Column:
    return col(revenue) - col(cost)


def customer_tier(total, orders, vip=(5000, 10), frequent=5, high_value=1000) -> Column:
    vip_label, frequent_label, high_label, rest = CUSTOMER_TIERS
    rules = [
        ((col(total) >= exact(vip[0])) & (col(orders) >= vip[1]), vip_label),
        (col(orders) >= frequent, frequent_label),
        (col(total) >= exact(high_value), high_label),
    ]
    return first_label(rules, rest)


def customer_segment(total, count, total_over=10000, count_over=10) -> Column:
    vip_label, frequent_label, rest = CUSTOMER_SEGMENTS
    rules = [(col(total) > exact(total_over), vip_label), (col(count) > count_over, frequent_label)]
    return first_label(rules, rest)


def product_tier(revenue, orders, margin, star=(10000, 50), performer=5000, popular=20, high_margin=0.3) -> Column:
    """``margin`` is a ratio, not a percentage."""
    labels = PRODUCT_TIERS
    rules = [
        ((col(revenue) >= exact(star[0])) & (col(orders) >= star[1]), labels[0]),
        (col(revenue) >= exact(performer), labels[1]),
        (col(orders) >= popular, labels[2]),
        (col(margin) >= F.lit(float(high_margin)), labels[3]),
    ]
    return first_label(rules, labels[4])


def volume_category(quantity, steps=VOLUME_STEPS) -> Column:
    return at_least(quantity, steps, VOLUME_REST)


def abc_class(running: Column | str, total: Column | str, shares=ABC_SHARES) -> Column:
    """Class by cumulative share, compared as exact products."""
    rules = [(col(running) <= col(total) * exact(share), label) for share, label in shares]
    return first_label(rules, ABC_REST)
