"""Derived views: recurring charges, bills and payments, trips, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapsed_charges(charges: DataFrame, key: str, day: str, ident: str, within: int = 3) -> DataFrame:
    """Charges without those less than ``within`` (one at least) days after the last one kept.

    Of a day the charge with the least identifier alone can stay, so a key is first reduced to its days; each decision
    depends on the one before it, which no window frame can say, so the days are then taken in order as one array.
    """
    firsts = charges.groupBy(key, day).agg(F.min_by(F.struct(*charges.columns), ident).alias("c"))
    days = firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(day), F.col("c")))).alias("days"))
    fresh = lambda kept, x: (F.size(kept) == 0) | (x[day] - F.try_element_at(kept, F.lit(-1))[day] >= within)
    kept = F.aggregate("days", F.slice("days", 1, 0), lambda kept, x: F.when(fresh(kept, x), F.array_append(kept, x)).otherwise(kept))
    return days.select(F.inline(kept)).select("c.*")


def cadence(charges: DataFrame, key: str, day: str, amount: str, least: int = 3, slack: float = 0.25, steady: float = 0.75) -> DataFrame:
    """Keys whose gaps are steady: at least that share of them within the slack of the upper median; with the next day due."""
    w = Window.partitionBy(key).orderBy(day)
    gaps = charges.withColumn("gap", F.col(day) - F.lag(day).over(w))
    per = gaps.groupBy(key).agg(F.count(F.lit(1)).alias("charges"), F.max(day).alias("last_day"), F.round(F.sum(amount), 2).alias("total_amount"), F.array_sort(F.collect_list("gap")).alias("gaps"))
    per = per.where(F.col("charges") >= least).withColumn("median_gap", F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")))
    near = F.size(F.filter("gaps", lambda g: F.abs(g - F.col("median_gap")) <= slack * F.col("median_gap")))
    return per.where(near >= steady * F.size("gaps")).select(key, "charges", "last_day", "total_amount", "median_gap", (F.col("last_day") + F.col("median_gap")).alias("next_due"))


def first_payment(bills: DataFrame, payments: DataFrame, key: str, at: str, within: int) -> DataFrame:
    """For each bill the first payment of its key after it and within so many seconds. Both sides are put in one ordered list by key, so there is no inequality join."""
    both = bills.select(key, F.col(at), F.col("id").alias("bill"), F.lit(None).cast("bigint").alias("payment")).unionByName(payments.select(key, F.col(at), F.lit(None).cast("bigint").alias("bill"), F.col("id").alias("payment")))
    ahead = Window.partitionBy(key).orderBy(at, F.col("payment").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("p", F.first(F.when(F.col("payment").isNotNull(), F.struct(F.col(at).alias("paid_at"), "payment")), ignorenulls=True).over(ahead))
    ok = F.col("p.paid_at") - F.col(at) <= within
    return found.where("bill is not null").select(key, "bill", F.when(ok, F.col("p.payment")).alias("payment"))


def sessions(legs: DataFrame, key: str, start: str, end: str, gap: int, order: list[str]) -> DataFrame:
    """Legs numbered by trip: a new one begins more than ``gap`` after the latest end so far."""
    w = Window.partitionBy(key).orderBy(start, *order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (F.col(start) - before > gap)).cast("int")
    return legs.withColumn("__f", fresh).withColumn("trip", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def first_match(df: DataFrame, splits: dict[str, Column], other: str = "other") -> Column:
    """The first split, in the order given, that takes a row."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in splits.items()], F.lit(other))


#: Cadence, its nominal days, and the bounds of the median gap.
CADENCES = (("Weekly", 7.0, 6.0, 8.0), ("Monthly", 30.44, 26.0, 35.0), ("Quarterly", 91.3, 84.0, 98.0), ("Yearly", 365.25, 350.0, 380.0))


def recurring(charges: DataFrame, keys: list[str], day: str, amount: str, today: Column) -> DataFrame:
    """Keys that are charged at a cadence: the upper median gap names it, three quarters of the gaps (rounded up) lie near its
    bounds, and the last three amounts within a quarter of their median. Yearly needs two charges, all others three.

    Returns the last amount, its worth by month, the next day due and whether the charge is active, late or stopped.
    ``charges`` has a row a key and day (``collapsed_charges``), so what is gathered of a key is bounded by its days.
    Charges without a day or an amount above zero do not count.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    gaps = charges.where((F.col(amount) > 0) & F.col(day).isNotNull()).withColumn("gap", F.datediff(F.col(day), F.lag(day).over(w)))
    per = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("charges"), F.max(day).alias("last_day"), F.max_by(amount, day).alias("amount"), F.array_sort(F.collect_list("gap")).alias("gaps"), F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(day, amount)))), 1, 3).alias("recent"))
    per = per.where("charges > 1").withColumn("median", F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")))
    which = F.lit(None)
    for name, nominal, lo, hi in CADENCES:
        made = F.struct(F.lit(name).alias("cadence"), F.lit(nominal).alias("nominal"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        which = F.coalesce(which, F.when(F.col("median").between(lo, hi), made))
    per = per.withColumn("c", which).where("c is not null").where((F.col("c.cadence") == "Yearly") | (F.col("charges") > 2))
    steady = F.size(F.filter("gaps", lambda g: g.between(F.col("c.lo") * 0.85, F.col("c.hi") * 1.15)))
    values = F.array_sort(F.transform("recent", lambda r: r[amount]))
    middle = F.get(values, F.floor(F.size(values) / 2).cast("int"))
    per = per.where(steady >= F.ceil(F.size("gaps") * 0.75)).withColumn("mid", middle).where(F.forall("recent", lambda r: F.abs(r[amount] - F.col("mid")) <= F.col("mid") * 0.25))
    over = F.datediff(today, F.col("last_day")) - F.col("c.nominal")
    grace = F.greatest(F.col("c.nominal") * 0.5, F.lit(7.0))
    status = F.when(over <= grace, "active").when(over <= grace + F.col("c.nominal"), "late").otherwise("stopped")
    return per.select(*keys, F.col("c.cadence").alias("cadence"), "charges", "amount", F.round(F.col("amount") * 30.44 / F.col("c.nominal"), 2).alias("per_month"), F.date_add("last_day", F.floor("c.nominal").cast("int")).alias("next_due"), status.alias("status"))


def bill_states(bills: DataFrame, payments: DataFrame, key: str, today: Column) -> DataFrame:
    """One row a bill (the newest of a key and invoice) with the payment that settles it and its state.

    ``bills`` and ``payments`` have id, ``key``, invoice, amount and day (of the message), bills also due. A payment settles a bill of
    its key from the bill's day on if invoices or amounts agree; of several the newest is named. It is enough to know the newest payment
    of each (key, invoice) and (key, amount), so two equi-joins decide and no pairs are made. Unpaid: overdue for 30 days from the due
    day on, due before it (or for 45 days without one), then earlier. A null invoice or amount agrees with nothing.
    """
    w = Window.partitionBy(key, F.coalesce(F.col("invoice").cast("string"), F.concat(F.lit("#"), F.col("id").cast("string")))).orderBy(F.desc("day"), F.desc("id"))
    newest = bills.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    last = lambda by: payments.where(F.col(by).isNotNull()).groupBy(key, by).agg(F.max(F.struct("day", "id")).alias(f"p_{by}"))
    met = newest.join(last("invoice"), [key, "invoice"], "left").join(last("amount"), [key, "amount"], "left")
    later = lambda by: F.when(F.col(f"p_{by}.day") >= F.col("day"), F.col(f"p_{by}"))
    met = met.withColumn("paid", F.greatest(later("invoice"), later("amount")))
    state = (
        F.when(F.col("paid").isNotNull(), "paid")
        .when((F.col("due") < today) & (F.col("due") >= F.date_sub(today, 30)), "overdue")
        .when(F.col("due") >= today, "due")
        .when(F.col("due").isNull() & (F.datediff(today, F.col("day")) <= 45), "due")
        .otherwise("earlier")
    )
    return met.select("id", key, "invoice", "amount", "due", state.alias("state"), F.col("paid.id").alias("payment"))
