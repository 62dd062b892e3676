"""Administrative codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area_code(c: Column | str) -> Column:
    """Two digits, padded with zeros and cut; null for what is not all ASCII digits, so also for _unknown and \\N."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when(text.rlike("^[0-9]+$"), F.lpad(text, 2, "0"))


def request_code(c: Column | str) -> Column:
    """Trimmed and padded to two characters, never cut."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.lpad(text, F.greatest(F.lit(2), F.length(text)), F.lit("0"))


# What an endpoint's access or action says when it may not be called.
REFUSED_ACTION = "do_not_call"
REFUSED_ACCESS = ("auth_401", "http_401", "http_403", "needs_auth", "requires_auth", "login", "error")


def restricted_endpoint(policy: Column, access: Column, action: Column) -> Column:
    """Whether an endpoint stays local: by its policy, its action, or any of the words in its access. Null counts as empty."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    out = F.coalesce(policy == "restricted_local_only", F.lit(False)) | F.startswith(low(action), F.lit(REFUSED_ACTION))
    for word in REFUSED_ACCESS:
        out = out | F.contains(low(access), F.lit(word))
    return out
