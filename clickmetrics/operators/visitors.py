"""New versus repeat visits and revenue.

"Rank" in the reference is ``DENSE_RANK() OVER (PARTITION BY user_id ORDER BY
website_session_id)`` and is only ever tested for ``= 1`` or ``> 1``, i.e.
"is this the user's smallest session id".  That is a per-user ``min`` /
``min_by`` (combined map-side), so a user owning a large share of sessions
never lands in one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmetrics.functions.compat import round_half_away, soundex_difference
from clickmetrics.operators.sessions import SESSION, USER


def revenue_by_visit_rank(ws: DataFrame, o: DataFrame, oi: DataFrame, which: str = "new") -> DataFrame:
    """M05 (``which='new'``) / M06 (``'repeat'``): item revenue of the user's first
    *ordering* session, or of later ones.

    Rank is taken after joining orders and items (so "first" means the first
    session with an ordered item), over distinct (user, session, item, price)
    rows; the sum is cast to double and rounded to 2.  Revenue is summed per
    session, then per user ``min_by(revenue, session)`` is the first
    session's share: one aggregation chain, combined map-side at every step,
    with no join on the user.  ``website_session_id`` is the sessions key
    (one user per session).
    """
    if which not in ("new", "repeat"):
        raise ValueError("which must be 'new' or 'repeat'")
    items = (o.select("order_id", SESSION)
             .join(oi.select("order_id", "order_item_id", "price_usd"), "order_id", "inner")
             .select(SESSION, "order_item_id", "price_usd").distinct())
    per_session = (items.groupBy(SESSION).agg(F.sum("price_usd").alias("_rev"))
                   .join(ws.select(SESSION, USER), SESSION, "inner"))
    per_user = per_session.groupBy(USER).agg(F.min_by("_rev", SESSION).alias("_first"),
                                             F.sum("_rev").alias("_all"), F.count("_rev").alias("_priced"))
    if which == "new":
        part = F.col("_first")
    else:  # NULL for a user without a priced later session, as a SUM over no values
        later = F.col("_priced") - F.col("_first").isNotNull().cast("int")
        part = F.when(later > 0, F.col("_all") - F.coalesce(F.col("_first"), F.lit(0)))
    name = "revenue_new_sessions" if which == "new" else "revenue_repeat_sessions"
    return per_user.agg(round_half_away(F.sum(part).cast("double"), 2).alias(name))


def new_vs_repeat(ws: DataFrame) -> DataFrame:
    """Distinct (user, session) pairs whose session is the user's first, and the rest.

    Each user group (NULL users form one) has exactly one first session, so
    ``new`` is the number of user groups and ``repeat`` the remaining pairs:
    two aggregates, no join.
    """
    pairs = ws.select(USER, SESSION).where(F.col(SESSION).isNotNull()).distinct()
    per_user = pairs.groupBy(USER).agg(F.count(F.lit(1)).alias("_n"))
    return per_user.agg(F.count(F.lit(1)).alias("new_visitor"),
                        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("repeat_visitor"))


def repeat_by_flag(ws: DataFrame) -> DataFrame:
    """Sessions flagged repeat, and the rest (``total - repeat``, the intent)."""
    return ws.agg(
        F.count(F.when(F.col("is_repeat_session") == 1, F.col(SESSION))).alias("repeat_visitors"),
        (F.count(SESSION) - F.count(F.when(F.col("is_repeat_session") == 1, F.col(SESSION)))).alias("new_visitors"),
    )


def repeat_by_flag_literal(ws: DataFrame) -> DataFrame:
    """M13 as literally written: ``DIFFERENCE(total, repeat)`` is a SOUNDEX
    similarity (0-4), not a subtraction."""
    counts = ws.agg(
        F.count(F.when(F.col("is_repeat_session") == 1, F.col(SESSION))).alias("repeat_visitors"),
        F.count(SESSION).alias("total_visitor"),
    )
    return counts.select("repeat_visitors", soundex_difference("total_visitor", "repeat_visitors").alias("difference"))


def first_session_per_user(ws: DataFrame) -> DataFrame:
    """Each user's first session (smallest id); NULL users form one group."""
    return ws.groupBy(USER).agg(F.min(SESSION).alias(SESSION))
