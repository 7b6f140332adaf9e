"""Registered query: the customer profile itself."""

from __future__ import annotations

from churnlake.plans.inputs import PROFILE_CTE, profile
from churnlake.plans.registry import query
from churnlake.schema import PROFILE


@query("customer_profile", f"with {PROFILE_CTE} select {', '.join(f.name for f in PROFILE.fields)} from profile")
def customer_profile(spark, folder):
    return profile(spark, folder)
