"""Column expressions with the numeric, text and date semantics of the reports."""

from partner_analytics.functions.dates import *  # noqa: F401,F403
from partner_analytics.functions.ladders import *  # noqa: F401,F403
from partner_analytics.functions.numeric import *  # noqa: F401,F403
from partner_analytics.functions.text import *  # noqa: F401,F403
