from tierscope.streaming.refresh import (MONTH_LOCAL_REPORTS, read_report, refresh_months,
                                        start_refresh)

__all__ = ["MONTH_LOCAL_REPORTS", "read_report", "refresh_months", "start_refresh"]
