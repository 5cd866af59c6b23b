from tierscope.functions.expr import (FREE_TIERS, FREE_TO_PAID, PAID_UPGRADE, PLAN_ORDER,
                                     asc_pg, desc_pg, exact_sum, int_div, nullif_blank, pct,
                                     plan_rank, plan_sort_key, round_avg, round_div,
                                     round_half_up_double, whole_months, years_from_months,
                                     PLAN_TEXT_ORDER, plan_from_rank, plan_from_text_code,
                                     plan_text_code)

__all__ = ["FREE_TIERS", "FREE_TO_PAID", "PAID_UPGRADE", "PLAN_ORDER", "asc_pg", "desc_pg",
           "exact_sum", "int_div", "nullif_blank", "pct", "plan_rank", "plan_sort_key",
           "round_avg", "round_div", "round_half_up_double", "whole_months",
           "years_from_months", "PLAN_TEXT_ORDER", "plan_from_rank", "plan_from_text_code",
           "plan_text_code"]
