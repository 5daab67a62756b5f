"""The reference's literal values, used as the operators' defaults.

Fixed values: they must equal the reference's for the analyses to mean the
same thing.  Listed together, as text, in the order the reference uses them.
"""

# Missing-value marker and the labels that replace it.
MISSING_MARKER = "NULL"
DIRECT_SOURCE = "Direct_Source"
DIRECT_SEARCH = "Direct_Search"

# The paid campaign the landing-page analyses filter on.
CAMPAIGN_SOURCE = "gsearch"
CAMPAIGN_NAME = "nonbrand"

# Pages and the labels of the landing-page test arms.
HOME_PAGE = "/home"
LANDER_PAGE = "/lander-1"
HOME_LABEL = "Home"
LANDER_LABEL = "Lander-1"
BILLING_PAGES = ("/billing", "/billing-2")
GOAL_PAGE = "/thank-you-for-your-order"

# The conversion funnel as (step name, page, rate-column prefix).
FUNNEL_STEPS = (
    ("lander", "/lander-1", "lander"),
    ("product", "/products", "products"),
    ("fuzzy", "/the-original-mr-fuzzy", "fuzzy"),
    ("cart", "/cart", "cart"),
    ("shipping", "/shipping", "shipping"),
    ("billing", "/billing", "billing"),
    ("thankyou", "/thank-you-for-your-order", "thankyou"),
)

# Date ranges and the cut-off of the dated analyses.
TREND_START = "2012-06-01"
TREND_END = "2012-08-31"
FUNNEL_START = "2012-08-05"
FUNNEL_END = "2012-09-05"
BILLING_CUTOFF = "2012-10-10"
