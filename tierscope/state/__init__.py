"""State kept beside the base table, so that reports over all history read none of it."""

from tierscope.state.customer_state import (conversion_funnel, new_customers, new_customers_of_note,
                                            read_state, state_of, stopped_customers, update_state)

__all__ = ["conversion_funnel", "new_customers", "new_customers_of_note", "read_state", "state_of",
           "stopped_customers", "update_state"]
